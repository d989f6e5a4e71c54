"""Removal of repeated word sequences through a log-structured fingerprint index.

A window is WINDOW consecutive words of one text.  A window that starts at two
places or more, in one text or in several, is repeated, and each word that a
repeated window covers is removed everywhere.

Fingerprints.  Every window picks the K-word run in it with the least hash (the
leftmost of equals); equal windows pick equal runs, so a window can only be
repeated if its run's fingerprint occurs twice.  The index holds these
fingerprints with their counts, about a tenth of the windows' number.

Index.  An index is a folder that outlives a session.  Documents come in
batches; what a batch adds is flushed as sorted immutable runs of (fingerprint,
count), bucketed by fingerprint, so two runs are merge-joined without a
shuffle.  A new run is merge-joined with each historical run to find what they
share, and two runs of one level are merged into a run of the next level, so
there are only logarithmically many.  A manifest names the runs; each change
writes a new one, so an index whose writer died is as it was before.

Verification.  While a batch is scanned its rows are kept as compressed chunks
in the folder (one file a task, read by chunk and column), so texts are never
shuffled.  Windows of repeated fingerprints are looked at again: each gets a
cryptographic digest of its words, digests are compared within a fingerprint,
and only windows with equal words count.  Equal stretches within a chunk are
settled there; a fingerprint of more than GROUP occurrences is dealt over
several tasks, whose distinct digests are summed up afterwards, so no group is
gathered in one task.

Edge cases: a null text has no words; texts shorter than a window keep all
words; a very long text is a chunk of its own, whose words one worker holds;
repeated rows count as occurrences of their own; an empty table gives an
empty result; other columns come along unchanged only if asked for, in a
struct, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .batches import arrow, texts
from .storage import shared_dir, stored
from .wordhash import Words, mix, runs

WINDOW = 35
K = 15
#: Occurrences of a fingerprint that one task compares.
GROUP = 500
#: Bytes of text that a worker has in hand at once.
CHUNK_BYTES = 1 << 20
#: Chunks that a task reads again: their work is in the files, not in the rows that name them.
TASK_CHUNKS = 16
#: Runs that one pass over a table is flushed as.
FLUSHES = 4


def picks(words: Words, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the place of the run that each picks, and that run's fingerprint."""
    h = words.hashes()
    starts, _ = _window_starts(words, window)
    if not len(starts):
        return starts, starts, np.zeros(0, dtype=np.int64)
    _, grams = runs(h, np.array([0, len(h)]), k)
    value, at, reach = grams, np.arange(len(grams), dtype=np.int32), 1
    while reach < window - k + 1:
        d = min(reach, window - k + 1 - reach)
        less = value[d:] < value[:-d]
        value, at = np.where(less, value[d:], value[:-d]), np.where(less, at[d:], at[:-d])
        reach += d
    # A second mixing, as the least of many hashes is far from uniform.
    return starts, at[starts], mix(value[starts]).view(np.int64)


def _window_starts(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(words.starts)
    owner_end = np.repeat(words.first[1:], words.counts)
    return np.flatnonzero(np.arange(n) + window <= owner_end), owner_end


def digests(words: Words, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A 64-bit cryptographic digest of the words of each window."""
    size = words.ends - words.starts
    at = np.cumsum(size + 1) - (size + 1)
    body = b" ".join(words.buffer.tobytes().split())
    begin, end = at[starts].tolist(), (at[starts + window - 1] + size[starts + window - 1]).tolist()
    h = hashlib.blake2b
    return np.frombuffer(b"".join([h(body[a:b], digest_size=8).digest() for a, b in zip(begin, end, strict=True)]), dtype=np.int64)


class _ChunkFile:
    """An Arrow file of chunks, opened by the first of them."""

    def __init__(self, folder: str):
        self.path, self.n, self.out = f"{folder}/{uuid.uuid4().hex}.arrow", 0, None

    def add(self, batch: pa.RecordBatch) -> int:
        if self.out is None:
            fs, at = pafs.FileSystem.from_uri(self.path)
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            self.sink = fs.open_output_stream(at)
            self.out = pa.ipc.new_file(self.sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.out.write_batch(batch)
        self.n += 1
        return self.n - 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.sink.close()


def _read_chunk(path: str, part: int, *fields: int) -> pa.RecordBatch:
    """One chunk of a file, of all columns or of some."""
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as source:
        return pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=list(fields))).get_batch(part)


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def _scan(df: DataFrame, folder: str, number: int) -> DataFrame:
    """Chunks of ``df`` (key, text, ...) in files, and their fingerprints: rows of (chunk, path, part) and of (chunk, fp, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, file = TaskContext.get().partitionId(), 0, _ChunkFile(folder)
        try:
            for part, found in texts(batches, 1, CHUNK_BYTES):
                chunk, seq = number << 40 | task << 20 | seq, seq + 1
                place = file.add(part)
                _, at, fp = picks(Words(found))
                prints, counts = np.unique(fp[np.diff(at, prepend=-1) != 0], return_counts=True)
                n = len(prints) + 1
                first = lambda x, kind: pa.array([x] + [None] * (n - 1), kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, chunk)), first(file.path, pa.string()), first(place, pa.int32()), pa.array([None, *prints.tolist()], pa.int64()), pa.array([0, *counts.tolist()], pa.int64())], names=["chunk", "path", "part", "fp", "n"]
                )
        finally:
            file.close()

    return df.transform(arrow(run, _SCANNED))


_SCANNED = "chunk long, path string, part int, fp long, n long"


class Index:
    """Fingerprints of all batches so far, in a folder."""

    def __init__(self, spark: SparkSession, folder: str, state: dict):
        self.spark, self.folder, self.state = spark, folder, state

    @classmethod
    def new(cls, spark: SparkSession, folder: str | None = None) -> Index:
        """An empty index; its runs have as many buckets as shuffles have partitions."""
        folder = folder or shared_dir(spark, "index")
        return cls(spark, folder, {"version": 0, "buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "batches": [], "runs": []})

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        """The index as its last manifest has it."""
        fs, at = pafs.FileSystem.from_uri(folder)
        names = [x.path for x in fs.get_file_info(pafs.FileSelector(at)) if x.base_name.startswith("manifest-")]
        with fs.open_input_stream(max(names)) as f:
            return cls(spark, folder, json.loads(f.read()))

    def _commit(self, **changes) -> None:
        state = self.state | changes | {"version": self.state["version"] + 1}
        fs, at = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/manifest-{state['version']:08d}.json") as f:
            f.write(json.dumps(state).encode())
        self.state = state

    def run(self, name: str) -> DataFrame:
        """A stored run: fp, n."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (fp BIGINT, n BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.state['buckets']} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(name)

    def _write_run(self, counts: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.state["buckets"], "fp").sortBy("fp").option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        return name

    def _merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumnRenamed("n", "n_old").hint("merge").join(new, "fp", "full_outer")
        return both.select("fp", (F.coalesce("n_old", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"))

    def add(self, df: DataFrame, flushes: int = 1) -> int:
        """Take up a batch of key, text and more (the same columns every time), flushed as so many runs; the batch's number."""
        number = len(self.state["batches"])
        path = f"{self.folder}/prints-{uuid.uuid4().hex}"
        _scan(df, f"{self.folder}/chunks", number).write.parquet(path)
        prints = self._prints(path).where("path is null")
        runs, fresh = [list(x) for x in self.state["runs"]], []
        for i in range(flushes):
            mine = prints.where(F.pmod(F.xxhash64("chunk"), F.lit(flushes)) == i) if flushes > 1 else prints
            level, name = 0, self._write_run(mine.groupBy("fp").agg(F.sum("n").alias("n")))
            fresh.append(name)
            while any(lv == level for lv, _ in runs):
                old = next(x for x in runs if x[0] == level)
                runs.remove(old)
                level, name = level + 1, self._write_run(self._merged(self.run(old[1]), self.run(name)))
            runs.append([level, name])
        batch = {"prints": path.rsplit("/", 1)[1], "kinds": df.schema.json(), "fresh": fresh, "history": [name for _, name in self.state["runs"]]}
        self._commit(runs=runs, batches=[*self.state["batches"], batch])
        return number

    def _prints(self, path: str) -> DataFrame:
        return self.spark.read.schema(_SCANNED).parquet(path)

    def scanned(self, batches: list[int] | None = None) -> DataFrame:
        """Chunks and fingerprints of some batches, or of all."""
        chosen = self.state["batches"] if batches is None else [self.state["batches"][i] for i in batches]
        found = [self._prints(f"{self.folder}/{b['prints']}") for b in chosen]
        return reduce(DataFrame.union, found) if found else self.spark.createDataFrame([], _SCANNED)

    def repeated(self, batch: int | None = None) -> DataFrame:
        """fp and total of all fingerprints that occur twice or more; of those only that a batch has."""
        runs = [self.run(name) for _, name in sorted(self.state["runs"])]
        total = reduce(self._merged, runs) if runs else self.spark.createDataFrame([], "fp long, n long")
        if batch is not None:
            mine = reduce(self._merged, [self.run(name) for name in self.state["batches"][batch]["fresh"]])
            total = total.join(mine.select("fp").hint("merge"), "fp", "left_semi")
        return total.where("n > 1").select("fp", F.col("n").alias("total"))

    def known(self, batch: int) -> DataFrame:
        """fp: what a batch shares with the runs that were there before it, by a merge join with each."""
        state = self.state["batches"][batch]
        mine = reduce(self._merged, [self.run(name) for name in state["fresh"]])
        found = [self.run(name).select("fp").hint("merge").join(mine.select("fp"), "fp") for name in state["history"]]
        return reduce(DataFrame.union, found).distinct() if found else mine.select("fp").limit(0)


def _spans(flags: np.ndarray, chunks: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows that follow each other in a chunk: chunk, first, number."""
    c, b = chunks[flags], begins[flags]
    if not len(c):
        return c, b, b
    order = np.lexsort((b, c))
    c, b = c[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(c) != 0) | (np.diff(b) != 1)]))
    return c[new], b[new], np.diff(np.append(new, len(c)))


_FOUND = "kind int, fp long, hot boolean, part int, chunk long, begin int, length int, n int, digests binary"


def _rows(kind: int, fp, hot, part, chunk, begin, length, n, blobs) -> pa.RecordBatch:
    size = len(chunk)
    full = lambda x, t: pa.array(np.full(size, x) if np.isscalar(x) else x, t)
    return pa.RecordBatch.from_arrays(
        [full(kind, pa.int32()), full(fp, pa.int64()), full(hot, pa.bool_()), full(part, pa.int32()), full(chunk, pa.int64()), full(begin, pa.int32()), full(length, pa.int32()), full(n, pa.int32()), pa.array(blobs if blobs is not None else [None] * size, pa.binary())],
        names=["kind", "fp", "hot", "part", "chunk", "begin", "length", "n", "digests"],
    )


def _look_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (path, part, chunk, repeated prints) to spans that are settled (kind 0) and occurrences that aren't (kind 1)."""
    for batch in batches:
        for path, part, chunk, pairs in zip(*(batch.column(i) for i in range(4)), strict=True):
            known = pairs.values
            prints, totals = (known.field(i).to_numpy() for i in (0, 1))
            order = np.argsort(prints)
            prints, totals = prints[order], totals[order]
            chunk = chunk.as_py()
            words = Words(_bytes(_read_chunk(path.as_py(), part.as_py(), 1).column(0)))
            starts, at, fp = picks(words)
            place = np.minimum(np.searchsorted(prints, fp), len(prints) - 1)
            keep = prints[place] == fp
            starts, at, fp, total = starts[keep], at[keep], fp[keep], totals[place[keep]]
            if not len(starts):
                continue
            d = digests(words, starts)
            first = np.flatnonzero(np.diff(at, prepend=-1) != 0)
            length = np.diff(np.append(first, len(at)))
            # Occurrences with equal digests (their sum with the fingerprint, then the bytes) are settled here.
            body = d.tobytes()
            blobs = [body[8 * a : 8 * (a + n)] for a, n in zip(first.tolist(), length.tolist(), strict=True)]
            seen: dict[tuple[int, bytes], int] = {}
            same = np.array([seen.setdefault((f, b), i) for i, (f, b) in enumerate(zip(fp[first].tolist(), blobs, strict=True))])
            times = np.bincount(same, minlength=len(first))
            again = times[same] > 1
            if again.any():
                yield _rows(0, 0, False, 0, np.full(int(again.sum()), chunk), starts[first][again], length[again], 0, None)
            once = np.flatnonzero(times > 0)
            n_total = total[first][once]
            parts = -(-n_total // GROUP)
            salt = (mix(np.array([chunk]))[0] % parts.astype(np.uint64)).astype(np.int64)
            yield _rows(1, fp[first][once], parts > 1, salt, np.full(len(once), chunk), starts[first][once], length[once], np.minimum(times[once], 2), [blobs[i] for i in once])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences sorted by fingerprint and part to spans (kind 0), and the distinct digests of hot prints (kind 2)."""
    waiting: list[pa.RecordBatch] = []

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        col = {c: table.column(c).to_numpy() for c in ("fp", "hot", "chunk", "begin", "length", "n")}
        d = np.frombuffer(b"".join(table.column("digests").to_pylist()), dtype=np.int64)
        row = np.repeat(np.arange(table.num_rows), col["length"])
        begin = col["begin"][row] + np.arange(len(row)) - np.repeat(np.cumsum(col["length"]) - col["length"], col["length"])
        fp = col["fp"][row]
        order = np.lexsort((d, fp))
        new = np.concatenate([[True], (np.diff(fp[order]) != 0) | (np.diff(d[order]) != 0)])
        group = np.empty(len(row), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.bincount(group, col["n"][row])[group]
        chunk, begin_of, length = _spans(total > 1, col["chunk"][row], begin)
        if len(chunk):
            yield _rows(0, 0, False, 0, chunk, begin_of, length, 0, None)
        hot = np.zeros(len(row), dtype=bool)
        hot[order[new]] = True
        hot &= col["hot"][row]
        if hot.any():
            yield _rows(2, fp[hot], True, 0, col["chunk"][row][hot], begin[hot], 1, np.minimum(total[hot], 2), [x.tobytes() for x in d[hot]])

    for batch in batches:
        # Rows of the last fingerprint and part may go on in the next batch.
        keys = np.stack([batch.column(1).to_numpy(), batch.column(3).to_numpy()])
        cut = batch.num_rows
        while cut and (keys[:, cut - 1] == keys[:, -1]).all():
            cut -= 1
        if cut or waiting:
            first_new = 0
            if waiting:
                last = waiting[-1]
                while first_new < batch.num_rows and keys[0, first_new] == last.column(1)[-1].as_py() and keys[1, first_new] == last.column(3)[-1].as_py():
                    first_new += 1
            if first_new == batch.num_rows:
                waiting.append(batch)
                continue
            cut = max(cut, first_new)
            done = [*waiting, batch.slice(0, cut)]
            waiting = []
            yield from work(pa.Table.from_batches(done))
        if cut < batch.num_rows:
            waiting.append(batch.slice(cut))
    if waiting:
        yield from work(pa.Table.from_batches(waiting))


def _tasks(chunks: DataFrame) -> int:
    return max(1, -(-chunks.count() // TASK_CHUNKS))


def repeated_spans(index: Index, batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks (chunk, path, part) of the index, and spans of repeated windows (chunk, begin, length).

    With a batch: its chunks only, and the windows that repeat in it or in any other batch.
    """
    scanned = index.scanned()
    every = scanned.where("path is not null").select("chunk", "path", "part")
    prints = scanned.where("path is null").select("chunk", "fp").join(index.repeated(batch).hint("merge"), "fp")
    asked = prints.groupBy("chunk").agg(F.collect_list(F.struct("fp", "total")).alias("pairs"))
    rows = every.join(asked, "chunk").select("path", "part", "chunk", "pairs")
    looked = stored(rows.repartition(_tasks(every), "chunk").transform(arrow(_look_again, _FOUND)), "looked")
    open_rows = looked.where("kind = 1").repartition("fp", "part").sortWithinPartitions("fp", "part")
    compared = stored(open_rows.transform(arrow(_compare, _FOUND)), "compared")
    # A digest that several parts of a hot fingerprint hold once each is repeated too.
    hot = compared.where("kind = 2")
    sums = hot.groupBy("fp", "digests").agg(F.sum("n").alias("all")).where(F.col("all") > 1)
    late = hot.where("n = 1").join(sums.hint("merge"), ["fp", "digests"]).select("chunk", "begin", F.lit(1).alias("length"))
    spans = looked.where("kind = 0").select("chunk", "begin", "length").unionByName(compared.where("kind = 0").select("chunk", "begin", "length")).unionByName(late)
    if batch is None:
        return every, spans
    return index.scanned([batch]).where("path is not null").select("chunk", "path", "part"), spans


def _remove(window: int, verbatim: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, part, begins, lengths in zip(*(batch.column(i) for i in range(4)), strict=True):
                rows = _read_chunk(path.as_py(), part.as_py())
                found = _bytes(rows.column(1))
                split = [(t or b"").split() for t in found]
                counts = np.array([len(x) for x in split], dtype=np.int64)
                first = np.concatenate([[0], np.cumsum(counts)])
                covered = np.zeros(int(first[-1]) + 1, dtype=np.int64)
                if begins.is_valid and len(begins):
                    begin, length = begins.values.to_numpy().astype(np.int64), lengths.values.to_numpy().astype(np.int64)
                    np.add.at(covered, begin, 1)
                    np.add.at(covered, begin + length + window - 1, -1)
                gone = np.cumsum(covered)[:-1] > 0
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
                kept = [
                    (t if verbatim else b" ".join(x)) if not r else b" ".join([w for w, g in zip(x, gone[a:b].tolist(), strict=True) if not g])
                    for t, x, r, a, b in zip(found, split, removed.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)
                ]
                del split, found
                extra = [rows.column(i) for i in range(2, rows.num_columns)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts), pa.array(removed), *extra], names=["key", "kept", "n_words", "n_removed", *rows.schema.names[2:]])

    return run


def prepared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """What an index takes up: key, text, and a struct ``carried`` of the columns to carry."""
    return df.select(df[id_col].alias("key"), df[text_col].alias("text"), *([F.struct(*(df[c] for c in carry)).alias("carried")] if carry else []))


def kept(index: Index, batch: int | None = None, verbatim: bool = False) -> DataFrame:
    """key, kept (the kept words, joined by a space), n_words, n_removed and any carried columns of all rows, or of a batch's.

    verbatim: a text without repeated words is kept as it is.
    """
    chunks, spans = repeated_spans(index, batch)
    by_chunk = spans.groupBy("chunk").agg(F.collect_list("begin").alias("begins"), F.collect_list("length").alias("lengths"))
    joined = chunks.join(by_chunk, "chunk", "left").select("path", "part", "begins", "lengths")
    fields = {f["name"]: f for f in json.loads(index.state["batches"][0]["kinds"])["fields"]}
    of = StructType.fromJson({"fields": list(fields.values())})
    schema = StructType([of["key"], StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), *([of["carried"]] if "carried" in fields else [])])
    return joined.repartition(_tasks(chunks), "path", "part").transform(arrow(_remove(WINDOW, verbatim), schema))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, flushes: int = FLUSHES, verbatim: bool = False) -> DataFrame:
    """``kept`` of a table as one batch of an index of its own."""
    index = Index.new(df.sparkSession)
    index.add(prepared(df, id_col, text_col, carry), flushes)
    return kept(index, verbatim=verbatim)
