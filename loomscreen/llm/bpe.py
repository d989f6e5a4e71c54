"""Byte-level BPE encoding and decoding through a sentencepiece model.

A sentencepiece BPE model is serialised straight from a rank vocabulary: every
token's bytes become a piece of one character a byte, scored by its negative
rank, under the identity normaliser.  Texts are split into pre-tokens by the
vocabulary's pattern; each distinct pre-token is encoded once and remembered.
Decoding maps ids back to their bytes.

Edge cases: a null or empty text has no ids; repeated rows are encoded alike;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import PART_BYTES, arrow
from .storage import columns

#: Pre-tokens remembered by a worker before its memory of them is cleared.
CACHE_PRETOKENS = 150_000
#: Matches handled at once, so that a huge text needs no huge list.
STEP = 200_000


def byte_chars() -> list[str]:
    """A printable character for each byte value, none of them white space."""
    return [chr(0x100 + b) for b in range(256)]


_CHARS = byte_chars()


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes are length-delimited, ints varints, floats 32-bit."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto; piece i is the i-th token by rank, an unknown piece comes last."""
    # Fixed values of the public sentencepiece schema: field numbers and enum values.
    piece_type_normal, piece_type_unknown, model_type_bpe = 1, 2, 2
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = "".join(_CHARS[b] for b in token).encode()
        out += _field(1, _field(1, text) + _field(2, -float(rank)) + _field(3, piece_type_normal))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, piece_type_unknown))
    out += _field(2, _field(3, model_type_bpe) + _field(4, len(ranks) + 1))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    """Encoder and decoder of one vocabulary; build it once a worker."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.by_rank = np.array(sorted(ranks.values()), dtype="<u4")
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.whole = {token: struct.pack("<I", rank) for token, rank in ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.pattern = regex.compile(pattern)
        self.table = {b: c for b, c in enumerate(_CHARS)}
        self.known: dict[str, bytes] = {}

    def _learn(self, pretokens: set[str]) -> None:
        if len(self.known) > CACHE_PRETOKENS:
            self.known.clear()
        new = [p for p in pretokens if p not in self.known]
        hard = []
        for p in new:
            if (ids := self.whole.get(p.encode())) is not None:
                self.known[p] = ids
            else:
                hard.append(p)
        for at in range(0, len(hard), 4096):
            part = hard[at : at + 4096]
            mapped = [p.encode().decode("latin-1").translate(self.table) for p in part]
            for p, pieces in zip(part, self.model.encode(mapped, num_threads=1), strict=True):
                self.known[p] = self.by_rank[pieces].tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(text) < STEP:
            found = [self.pattern.findall(text)]
        else:
            matches = self.pattern.finditer(text)
            found = iter(lambda: [m.group() for m in islice(matches, STEP)], [])
        out = []
        for pretokens in found:
            self._learn(set(pretokens))
            out.append(b"".join(map(self.known.__getitem__, pretokens)))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _lists(buffers: list[bytes]) -> pa.Array:
    """A list<int32> array of id buffers."""
    lengths = np.array([len(b) // 4 for b in buffers], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = np.frombuffer(b"".join(buffers), dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _parts(batch: pa.RecordBatch, sizes: np.ndarray, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose sizes sum to about ``most``, one row at least."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


def _encoded(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """The keys and ids of batches of (key, text), some rows at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        for part in _parts(batch, sizes):
            yield part.column(0), _lists([c.encode(t or "") for t in part.column(1).to_pylist()])


def _decoded(c: Codec, lists: pa.ListArray) -> pa.Array:
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return pa.array([c.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], type=pa.binary())


def encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row; a null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, lists in _encoded(codec(vocabulary, pattern), batches):
            yield pa.RecordBatch.from_arrays([keys, lists], names=["key", "ids"])

    return columns(df, key=id_col, text=text_col).transform(arrow(run, f"key {df.schema[id_col].dataType.simpleString()}, ids array<int>"))


def decode(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``df`` of ``key`` and ``ids`` with ``decoded`` (binary): the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(c, batch.column(1))], names=["key", "ids", "decoded"])

    return df.select("key", "ids").transform(arrow(run, f"key {df.schema['key'].dataType.simpleString()}, ids array<int>, decoded binary"))


def round_trip(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode`` of ``encode``, by one worker a task: the ids don't leave it in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for keys, lists in _encoded(c, batches):
            yield pa.RecordBatch.from_arrays([keys, lists, _decoded(c, lists)], names=["key", "ids", "decoded"])

    return columns(df, key=id_col, text=text_col).transform(arrow(run, f"key {df.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary"))


def digests(df: DataFrame, *more: str) -> DataFrame:
    """The counts and SHA-256 digests of what ``decode`` or ``round_trip`` returns, and any of its columns."""
    return df.select(
        F.col("key").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *more,
    )
