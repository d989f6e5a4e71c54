"""Block-compressed files (BGZF): lines and alignment records, read in splits.

A BGZF file is a chain of gzip blocks of up to 64 KB that name their own sizes,
so a reader can start at any byte: it looks for the next block.  A split has the
blocks that begin in its bytes, and the lines or records that begin in these
blocks (a line that begins with the next split's first byte is its last one);
the last of them may end in later blocks.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Compressed bytes of a split, and bytes of text in a block that is written.
SPLIT_BYTES = 16 << 20
BLOCK_TEXT = 60_000
#: Tasks of a read, at least, where there are as many splits; and compressed bytes that a task has at most, unless its split is larger.
LEAST_TASKS, TASK_BYTES = 64, 4 << 20
#: Fixed values of the formats: a block's first bytes, the empty block at a file's end, letters of bases and operations.
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
LINES = "file string, at long, m long, value string"
RECORDS = "file string, at long, m long, qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags string"


@dataclass
class Split:
    file: str
    start: int
    stop: int
    size: int
    names: tuple[str, ...] = ()


@dataclass
class Splits(InputPartition):
    """Consecutive splits that a task reads one after another: those of a stretch of a file."""

    file: str
    start: int
    stop: int
    size: int
    step: int
    names: tuple[str, ...] = ()

    def each(self) -> Iterator[Split]:
        for at in range(self.start, self.stop, self.step):
            yield Split(self.file, at, min(at + self.step, self.size), self.size, self.names)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Files at a path (a file or a folder) and their sizes; hidden ones are left out."""
    system, inner = _filesystem(path)
    info = system.get_file_info(inner)
    found = system.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def _block_size(head: bytes) -> int | None:
    """A block's bytes from its first ones; None if it isn't a block."""
    if len(head) < 18 or not head.startswith(MAGIC):
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        kind, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def _first_block(stream: pa.NativeFile, start: int, size: int) -> int:
    """The first block at or after ``start``: one that is followed by another or by the file's end."""
    if start == 0:
        return 0
    stream.seek(start)
    window = stream.read(1 << 17)
    at = window.find(MAGIC)
    while at >= 0:
        n = _block_size(window[at : at + 512])
        if n and (start + at + n == size or window[at + n : at + n + 4] == MAGIC):
            return start + at
        at = window.find(MAGIC, at + 1)
    return size


def _blocks(stream: pa.NativeFile, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Blocks' places and texts from a block on."""
    while at < size:
        stream.seek(at)
        raw = stream.read(1 << 16)
        n = _block_size(raw[:512])
        if n is None:
            raise ValueError(f"no block begins at byte {at}")
        yield at, zlib.decompress(raw[:n], 31)
        at += n


def _parts(split: Split) -> tuple[Iterator[bytes], Iterator[bytes]]:
    """The texts of the split's own blocks, and of those behind them (to be read in this order)."""
    system, inner = _filesystem(split.file)
    stream = system.open_input_file(inner)
    found = _blocks(stream, _first_block(stream, split.start, split.size), split.size)
    behind: list[bytes] = []

    def own() -> Iterator[bytes]:
        for at, text in found:
            if at >= split.stop:
                behind.append(text)
                return
            yield text

    def more() -> Iterator[bytes]:
        yield from behind
        yield from (text for _, text in found)

    return own(), more()


def split_lines(split: Split) -> Iterator[list[bytes]]:
    """The lines that begin in a split, some at a time."""
    own, more = _parts(split)
    rest, skipping = b"", split.start > 0
    for text in own:
        lines = (rest + text).split(b"\n")
        rest = lines.pop()
        if skipping:
            # What the split begins with ends a line of an earlier one.
            rest, skipping = (rest, False) if lines else (b"", True)
            lines = lines[1:]
        yield lines
    if skipping:
        return
    for text in more:
        end = text.find(b"\n")
        if end >= 0:
            yield [rest + text[:end]]
            return
        rest += text
    if rest:
        yield [rest]


def _head(data: bytes, at: int) -> tuple | None:
    """The fixed fields of the record at a place; None if there is too little."""
    return struct.unpack_from("<iiiBBHHHiiii", data, at) if at + 36 <= len(data) else None


def _plausible(data: bytes, at: int, n_names: int, ended: bool, deep: int = 4) -> bool | None:
    """Whether a chain of ``deep`` records (or all up to the file's end) begins here; None if that takes more data."""
    for k in range(deep):
        if ended and at == len(data):
            return k > 0
        h = _head(data, at)
        if h is None:
            return False if ended else None
        size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = h
        if not (-1 <= ref < n_names and -1 <= next_ref < n_names and pos >= -1 and next_pos >= -1 and l_name > 0 and l_seq >= 0):
            return False
        if not 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= size < 1 << 28:
            return False
        name = data[at + 36 : at + 36 + l_name]
        if len(name) == l_name and (name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1])):
            return False
        at += 4 + size
    return True


def _header(data: bytes) -> tuple[list[str], int] | None:
    """Names of references and the header's bytes; None if there are too few bytes."""
    try:
        if len(data) < 8:
            return None
        if data[:4] != b"BAM\x01":
            raise ValueError("the file doesn't begin with an alignment header")
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        (n,), at, names = struct.unpack_from("<i", data, at), at + 4, []
        for _ in range(n):
            (k,) = struct.unpack_from("<i", data, at)
            if at + 8 + k > len(data):
                return None
            names.append(data[at + 4 : at + 3 + k].decode())
            at += 8 + k
        return names, at
    except struct.error:
        return None


#: Numbers among the optional fields: struct's letter and size.
_NUMBERS = {"c": ("b", 1), "C": ("B", 1), "s": ("h", 2), "S": ("H", 2), "i": ("i", 4), "I": ("I", 4), "f": ("f", 4)}


def _tags(data: bytes) -> str:
    out, at = [], 0
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in _NUMBERS:
            letter, n = _NUMBERS[kind]
            (value,) = struct.unpack_from("<" + letter, data, at)
            out.append(f"{tag}:{'f' if kind == 'f' else 'i'}:{value:g}" if kind == "f" else f"{tag}:i:{value}")
            at += n
        elif kind == "A":
            out.append(f"{tag}:A:{chr(data[at])}")
            at += 1
        elif kind in "ZH":
            end = data.index(b"\0", at)
            out.append(f"{tag}:{kind}:{data[at:end].decode()}")
            at = end + 1
        elif kind == "B":
            of, (n,) = chr(data[at]), struct.unpack_from("<i", data, at + 1)
            letter, width = _NUMBERS[of]
            values = struct.unpack_from(f"<{n}{letter}", data, at + 5)
            out.append(f"{tag}:B:{of}" + "".join(f",{v:g}" if of == "f" else f",{v}" for v in values))
            at += 5 + n * width
        else:
            raise ValueError(f"unknown kind of field {kind!r}")
    return "\t".join(out)


def record(data: bytes, at: int, names: tuple[str, ...]) -> tuple:
    """The text fields of the record at a place, positions from 1, and the next one's place at the end."""
    size, ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_ref, next_pos, tlen = _head(data, at)
    end, at = at + 4 + size, at + 36
    qname = data[at : at + l_name - 1].decode()
    at += l_name
    cigar = "".join(f"{c >> 4}{OPERATIONS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", data, at)) or "*"
    at += 4 * n_cigar
    packed = data[at : at + (l_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq] or "*"
    at += len(packed)
    qual = data[at : at + l_seq]
    text = "*" if not qual or qual[0] == 255 else bytes(q + 33 for q in qual).decode("ascii")
    name = lambda k: names[k] if k >= 0 else "*"
    rnext = "=" if next_ref == ref and ref >= 0 else name(next_ref)
    return qname, flag, name(ref), pos + 1, mapq, cigar, rnext, next_pos + 1, tlen, seq, text, _tags(data[at + l_seq : end]), end


def split_records(split: Split) -> Iterator[tuple]:
    """The alignment records that begin in a split."""
    own, more = _parts(split)
    data, at, owned, own_done, ended = b"", 0, 0, False, False

    def pull() -> None:
        """The next block's text; what has been passed is let go."""
        nonlocal data, at, owned, own_done, ended
        data, owned, at = data[at:], owned - at, 0
        text = None if own_done else next(own, None)
        if text is not None:
            data += text
            owned = len(data)
            return
        own_done = True
        text = next(more, None)
        ended = text is None
        data += text or b""

    if split.start == 0:
        while (header := _header(data)) is None and not ended:
            pull()
        if header is None:
            return
        at = header[1]
    else:
        while (begins := at < owned and _plausible(data, at, len(split.names), ended)) is not True:
            if at < owned and begins is False:
                at += 1
            elif at >= owned and own_done:
                return
            else:
                pull()
    while True:
        if at < owned and (h := _head(data, at)) and at + 4 + h[0] <= len(data):
            *fields, at = record(data, at, split.names)
            yield tuple(fields)
        elif at >= owned and own_done:
            return
        elif ended:
            raise ValueError(f"{split.file} ends within a record")
        else:
            pull()


def encoded(row: tuple, places: dict[str, int]) -> bytes:
    """A record's bytes from qname, flag, rname, pos (from 1), mapq, cigar, rnext, pnext, tlen, seq and qual."""
    qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual = row
    seq, qual, cigar = ("" if x in (None, "*") else x for x in (seq, qual, cigar))
    ref = places.get(rname, -1)
    next_ref = ref if rnext == "=" else places.get(rnext, -1)
    steps = [(int(n), OPERATIONS.index(c)) for n, c in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    # The bases that a record spans pick its bin: the narrowest of 2**29, 2**26 ... 2**14 bases that holds it whole.
    first, last = pos - 1, pos - 2 + max(1, sum(n for n, k in steps if OPERATIONS[k] in "MDN=X"))
    place = next(((1 << 29 - w) // 7 + (first >> w) for w in range(14, 30, 3) if first >> w == last >> w), 0)
    packed = bytes(BASES.index(a) << 4 | BASES.index(b) for a, b in zip(seq[::2], (seq + "=")[1::2], strict=False))
    body = struct.pack("<iiBBHHHiiii", ref, first, len(qname) + 1, mapq, place, len(steps), flag, len(seq), next_ref, pnext - 1, tlen)
    body += qname.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | k) for n, k in steps) + packed + (bytes(ord(c) - 33 for c in qual) if qual else b"\xff" * len(seq))
    return struct.pack("<i", len(body)) + body


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: str, split_bytes: int, records: bool):
        self.path, self.schema, self.split_bytes, self.records = path, schema, split_bytes, records

    def partitions(self) -> list[Splits]:
        out, files = [], _files(self.path)
        # Small splits are read several to a task, so that a large table isn't a task for each of them.
        together = min(TASK_BYTES, sum(size for _, size in files) // LEAST_TASKS) // self.split_bytes
        stretch = max(1, together) * self.split_bytes
        for file, size in files:
            names: tuple[str, ...] = ()
            if self.records:
                data, header = b"", None
                for text in _parts(Split(file, 0, size, size))[0]:
                    data += text
                    if header := _header(data):
                        break
                names = tuple(header[0]) if header else ()
            out += [Splits(file, at, min(at + stretch, size), size, self.split_bytes, names) for at in range(0, size, stretch)]
        return out or [Splits("", 0, 0, 0, 1)]

    def read(self, splits: Splits) -> Iterator[pa.RecordBatch]:
        for split in splits.each():
            yield from self._read(split)

    def _read(self, split: Split) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in self.schema.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in self.schema.split(", ")]
        m = 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal m
            full = [(split.file, split.start, m + k, *r) for k, r in enumerate(rows)]
            m += len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*full, strict=True), kinds, strict=True)], names=names)

        if not self.records:
            for lines in split_lines(split):
                if lines:
                    yield batch([(line.rstrip(b"\r").decode("utf-8", "replace"),) for line in lines])
            return
        rows = []
        for r in split_records(split):
            rows.append(r)
            if len(rows) == 2000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


class _Writer(DataSourceWriter):
    """One block-compressed file a task, named by its partition; a task that runs again writes the same file."""

    def __init__(self, path: str, suffix: str = "gz", references: str | None = None):
        self.path, self.suffix, self.references = path, suffix, references

    def _texts(self, rows: Iterator) -> Iterator[bytes]:
        if self.references is None:
            yield from ((r[0] or "").encode() + b"\n" for r in rows)
            return
        known = [(n, int(k)) for n, k in (x.rsplit(":", 1) for x in self.references.split(","))]
        names = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in known)
        yield b"BAM\x01" + struct.pack("<ii", 0, len(known)) + names
        places = {n: k for k, (n, _) in enumerate(known)}
        yield from (encoded(tuple(r), places) for r in rows)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, inner = _filesystem(self.path)
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/part-{TaskContext.get().partitionId():05d}.{self.suffix}", compression=None) as out:
            pending = b""
            for text in self._texts(rows):
                pending += text
                while len(pending) >= BLOCK_TEXT:
                    out.write(block(pending[:BLOCK_TEXT]))
                    pending = pending[BLOCK_TEXT:]
            if pending:
                out.write(block(pending))
            out.write(END)
        return WriterCommitMessage()


def block(text: bytes) -> bytes:
    """One compressed block."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(text) + c.flush()
    return MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


class BlockLines(DataSource):
    """Lines of block-compressed files: file, at (the split's first byte), m (the line's number in the split) and value."""

    @classmethod
    def name(cls) -> str:
        return "block_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], LINES, int(self.options.get("splitBytes", SPLIT_BYTES)), False)

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


class BlockRecords(DataSource):
    """Alignment records of block-compressed binary files: file, at, m, and the text form's fields."""

    @classmethod
    def name(cls) -> str:
        return "block_records"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], RECORDS, int(self.options.get("splitBytes", SPLIT_BYTES)), True)

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], "bam", self.options["references"])


def lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of the block-compressed files at a path."""
    spark.dataSource.register(BlockLines)
    return spark.read.format("block_lines").option("splitBytes", split_bytes).load(path)


def alignments(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the binary alignment files at a path."""
    spark.dataSource.register(BlockRecords)
    return spark.read.format("block_records").option("splitBytes", split_bytes).load(path)


def write_lines(values: DataFrame, path: str) -> None:
    """Write a one-column table of lines (of records too, whose lines a newline parts) as block-compressed files, one a partition."""
    values.sparkSession.dataSource.register(BlockLines)
    values.write.format("block_lines").mode("append").save(path)


def write_alignments(records: DataFrame, path: str, references: dict[str, int]) -> None:
    """Write qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq and qual as binary alignment files, one a partition."""
    records.sparkSession.dataSource.register(BlockRecords)
    fields = [f.split()[0] for f in RECORDS.split(", ")][3:-1]
    listed = ",".join(f"{n}:{k}" for n, k in references.items())
    records.select(*fields).write.format("block_records").option("references", listed).mode("append").save(path)
