"""Token ids as Arrow stream files of fixed-size-list batches.

All documents' ids, in ascending key order and each closed by an end id, form
one stream.  Range partitions of the key write consecutive pieces of it.  A
file is an Arrow IPC stream whose batches hold two fixed-size-list columns:
``ids`` (sequences of equal length, in the narrowest unsigned type that holds
the vocabulary) and ``mask`` (1 for an id, 0 for padding after a file's last
id).  Every batch but the last has the same number of rows, so a memory map
gives any sequence or id by arithmetic, without a copy.

Ids come from the tokenizers library.  White space separates words for this
vocabulary kind and is dropped, so each distinct white-space-free word is
encoded once by the library and remembered.  That needs a tokenizer whose
normaliser and pre-tokeniser drop white space; ``Encoder`` checks it.

Files are written under a name of their own for each attempt, and a manifest
(one row a document: file, place, count) names those of the attempts that
succeeded, so retried or speculative tasks leave the result unchanged.

Edge cases: a null or empty text has only the end id; rows that share a key
are ordered by a hash of their text, then by the text; an empty table gives no files and no rows; other
columns of the input are ignored; long texts may span any number of sequences.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .batches import arrow, texts
from .storage import columns, shared_dir, stored

SEQUENCE = 2048
#: Sequences in a batch, and ids in a file before the next one is begun.
BATCH_ROWS = 256
FILE_IDS = 64 << 20
CACHE_WORDS = 400_000
MANIFEST = "doc_id {kind}, tie long, file string, nth long, place long, n_tokens long"


#: Arrow splits at a subset of the ASCII white space in some versions: all of it becomes spaces first.
_SPACES = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")


# The make of vocabulary whose words are normalised and split here.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}


def _pre_tokeniser(pattern: str) -> dict:
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True}
    return {"type": "Sequence", "pretokenizers": [split, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class Filled(dict):
    """A dictionary that computes what it misses."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Ids of texts: a distinct word is looked at once, a distinct pre-token encoded once.

    Words of printable characters up to U+024F are lower-cased (by the
    tokenizer's own normaliser if they aren't ASCII) and split by its own
    pattern here, and only pre-tokens go to the library's model; all other
    words, and vocabularies of another make, go through the whole library.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known = Filled(self._word)
        self.pieces = Filled(self._piece)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.model = self.tokenizer.model
        self.special = [t["content"] for t in made.get("added_tokens") or []]
        self.pattern = self._pattern(made)
        probe = "Ab c,\td\n\n e's 12 Ünï don't--x"
        if [i for w in probe.encode().split() for i in self._library(w.decode())] != self._library(probe):
            raise ValueError(f"{path}: white space has tokens of its own in this vocabulary")

    @staticmethod
    def _pattern(made: dict) -> regex.Pattern | None:
        """The pattern of the pre-tokens if normaliser, pre-tokeniser and all else but the vocabulary are of the make that is handled here."""
        parts = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        pattern = (parts[0].get("pattern") or {}).get("Regex")
        rest = {k: made.get(k) for k in ("post_processor", "truncation", "padding")}
        model = {k: (made.get("model") or {}).get(k) for k in ("type", "dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")}
        if not pattern or made.get("normalizer") != NORMALISER or made["pre_tokenizer"] != _pre_tokeniser(pattern) or any(rest.values()) or model.pop("type") != "BPE" or any(model.values()):
            return None
        return regex.compile(pattern)

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else self.bytes.pre_tokenize_str(piece)[0][0]
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        s = word.decode()
        if self.pattern and s.isprintable() and (s.isascii() or max(s) < "\u0250") and not ("<" in s and any(t in s for t in self.special)):
            s = s.lower() if s.isascii() else self.tokenizer.normalizer.normalize_str(s)
            return self.pieces[s] if s.isalpha() else b"".join(map(self.pieces.__getitem__, self.pattern.findall(s)))
        return np.array(self._library(s), dtype="<u4").tobytes()

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of each text's ids."""
        for seen in (self.known, self.pieces):
            if len(seen) > CACHE_WORDS:
                seen.clear()
        lists = pc.ascii_split_whitespace(pa.array([(t or b"").translate(_SPACES) for t in texts], pa.large_binary()).cast(pa.large_string()))
        words = lists.flatten().dictionary_encode()
        code = words.indices.to_numpy()
        made = list(map(self.known.__getitem__, words.dictionary.cast(pa.large_binary()).to_pylist()))
        size = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
        flat, begin = np.frombuffer(b"".join(made), dtype="<u4"), np.cumsum(size) - size
        sizes = size[code]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.arange(total) + np.repeat(begin[code] - (ends - sizes), sizes)] if total else np.zeros(0, dtype="<u4")
        upto = np.concatenate([[0], ends])[np.asarray(lists.offsets)]
        return ids, np.diff(upto)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Writer:
    """One file: takes ids, writes whole batches, pads the last sequence."""

    def __init__(self, folder: str, dtype: np.dtype, sequence: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.arrows"
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        self.sink = fs.open_output_stream(self.path.replace(folder, at, 1))
        self.sequence, self.dtype = sequence, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n += len(ids)
        if self.n_waiting >= self.sequence * BATCH_ROWS:
            every = np.concatenate(self.waiting)
            full = len(every) // (self.sequence * BATCH_ROWS) * (self.sequence * BATCH_ROWS)
            for at in range(0, full, self.sequence * BATCH_ROWS):
                self._write(every[at : at + self.sequence * BATCH_ROWS], self.sequence * BATCH_ROWS)
            self.waiting, self.n_waiting = [every[full:]], len(every) - full

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), dtype=bool)
        mask[:real] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.n_waiting:
            every = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(every) // self.sequence) * self.sequence, dtype=self.dtype)
            padded[: len(every)] = every
            self._write(padded, len(every))
        self.out.close()
        self.sink.close()


class Reader:
    """Random access to a file's sequences, masks and ids through a memory map where there is one."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        self.source = pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)
        with pa.ipc.open_stream(self.source) as stream:
            self.batches = list(stream)
        self.sequence = self.batches[0].schema.field("ids").type.list_size if self.batches else SEQUENCE
        self.flat = [b.column(0).flatten().to_numpy() for b in self.batches]

    def row(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The i-th sequence and its mask."""
        batch, at = divmod(i, BATCH_ROWS)
        return self.flat[batch][at * self.sequence : (at + 1) * self.sequence], self.batches[batch].column(1)[at].values

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from ``start`` on; a view if they lie in one batch."""
        size, out = self.sequence * BATCH_ROWS, []
        while n > 0:
            batch, at = divmod(start, size)
            out.append(self.flat[batch][at : at + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, dtype="<u2")])

    def close(self) -> None:
        self.flat, self.batches = [], []
        self.source.close()


def write(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
) -> DataFrame:
    """Write all ids and return the manifest: doc_id, tie (hash of the text), file, nth (of the task's files), place, n_tokens."""
    spark = df.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        dtype = np.dtype("<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4")
        w, order = None, 0
        try:
            for part, found in texts(batches, 2, 8 << 20):
                places, files, nths = [], [], []
                ids, counts = enc.encode(found)
                ids = np.insert(ids.astype(dtype), np.cumsum(counts), end_id)
                counts = counts + 1
                ends = np.cumsum(counts)
                for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                    if w is None or w.n >= FILE_IDS:
                        if w:
                            w.close()
                        w, order = Writer(folder, dtype, sequence), order + 1
                    places.append(w.n)
                    w.add(ids[a:b])
                    files.append(w.path)
                    nths.append(order)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(files, pa.string()), pa.array(nths, pa.int64()), pa.array(places, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "tie", "file", "nth", "place", "n_tokens"])
        finally:
            if w:
                w.close()

    docs = columns(df, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    rows = docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return stored(rows.transform(arrow(run, MANIFEST.format(kind=kind), "8m")), "manifest")


def starts(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``file`` and ``base``: the ids before each file in the order of the stream.

    One row a file comes to the driver: files hold FILE_IDS ids or end with a
    partition, so their number doesn't follow the documents'.
    """
    files = manifest.groupBy("file").agg(F.min(F.struct("doc_id", "tie")).alias("least"), F.min("nth").alias("nth"), F.sum("n_tokens").alias("n"))
    base, out = 0, []
    for r in files.orderBy("least", "nth").collect():
        out.append((r.file, base))
        base += r.n
    return spark.createDataFrame(out, "file string, base long")


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    A task reads the manifest of whole files' documents in their order, so a
    file is opened once; files are opened where the rows are, by their URI.
    """
    kind = manifest.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            crcs = []
            for file, place, n in zip(*(batch.column(i).to_pylist() for i in (2, 4, 5)), strict=True):
                if file != opened:
                    if reader:
                        reader.close()
                    reader, opened = Reader(file), file
                crcs.append(zlib.crc32(np.ascontiguousarray(reader.ids(place, n), dtype="<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(4), batch.column(5), pa.array(crcs, pa.int64())], names=["doc_id", "file", "place", "n_tokens", "ids_crc32"])
        if reader:
            reader.close()

    read = manifest.transform(arrow(run, f"doc_id {kind}, file string, place long, n_tokens long, ids_crc32 long"))
    bases = starts(manifest.sparkSession, manifest)
    return read.join(bases, "file").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
